"""A Spark-first engine for document libraries: parsing, chunking, search, fusion, grounding and evaluation."""
