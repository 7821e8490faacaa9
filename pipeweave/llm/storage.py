"""Tables written to the shared folder: the library's, under the name that the operators use."""

from pipeweave.storage import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
