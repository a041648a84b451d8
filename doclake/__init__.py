"""doclake: document processing and text analytics as Spark DataFrame plans."""
