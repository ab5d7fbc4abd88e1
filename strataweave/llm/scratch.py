"""Tables in the shared folder, as in the rest of the library."""

from strataweave.sources.scratch import fresh_path, shared_dir, stored

__all__ = ["fresh_path", "shared_dir", "stored"]
