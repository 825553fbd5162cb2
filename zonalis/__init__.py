"""Wave and tide analysis of global fields on the HEALPix sphere, on Spark DataFrames."""

__version__ = "0.1.0"
