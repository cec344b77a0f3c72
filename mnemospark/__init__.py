"""Knowledge recall and training-data preparation as Spark plans."""
