"""bindscape: DataFrame operators for genomic signal and binding-site tables.

Every operator takes and returns Spark DataFrames.  Rows are identified by
``(chrom, start[, stop])``; coordinates are 0-based and half-open.
"""

__version__ = "0.1.0"
