"""voxframe: speech and transcript analytics expressed as Spark DataFrame plans."""
