"""Where operators write intermediate tables: the shared folder that the cluster names."""

from kinweave.sources.shared import materialize, shared_dir

__all__ = ["materialize", "shared_dir"]
