"""pixelspark: image and byte-stream analytics expressed as Spark DataFrames."""
