"""tableprobe: Spark jobs that give an honest first assessment of a tabular dataset."""
