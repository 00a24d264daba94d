"""cinelake: a Spark-first engine for identifying and cataloguing media files."""
