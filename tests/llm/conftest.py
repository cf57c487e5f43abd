import random

import pytest

WORDS = {
    "en": "the and with of thing ation here ness ing shall other was from",
    "fr": "les des une avec être très où ça français pour élève ment tion",
    "de": "der die und nicht über schön für größe ung keit ein sich auch",
}


@pytest.fixture(scope="session")
def texts():
    """Seeded texts of three languages with their labels."""
    rng = random.Random(5)
    out = []
    for i in range(120):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(30, 120))), lang))
    return out
