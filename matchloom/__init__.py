"""Football tracking analytics as Spark jobs, for many matches at once."""
