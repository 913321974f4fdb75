"""gridspark: spreadsheet analytics and training-data operators as Spark jobs."""
