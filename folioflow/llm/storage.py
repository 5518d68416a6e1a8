"""Cutting lineage through the folder that the cluster shares; see ``folioflow.sources.shared``."""

from folioflow.sources.shared import discard_written, shared_folder, written

__all__ = ["discard_written", "shared_folder", "written"]
