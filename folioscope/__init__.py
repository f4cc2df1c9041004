"""folioscope: literary emotion analytics over a corpus of books, as Spark jobs."""
