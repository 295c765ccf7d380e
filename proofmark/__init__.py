"""Label proofing on Spark: records in, checked labels and clean text out."""
