"""Tables in the folder that driver and executors share."""

from cartolith.storage import clear, discard, mark, shared_folder, written

__all__ = ["clear", "discard", "mark", "shared_folder", "written"]
