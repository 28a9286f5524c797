"""Tezgah: Spark-first analytics for contrastive text-retrieval collections."""

__version__ = "0.1.0"
