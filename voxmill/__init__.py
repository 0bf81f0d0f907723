"""voxmill: a PySpark-native engine for building clean speech datasets."""

__version__ = "0.1.0"
