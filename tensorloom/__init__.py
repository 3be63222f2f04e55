"""tensorloom: labelled tensor streams and corpus operators on PySpark."""
