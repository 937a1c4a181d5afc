"""caregrid: care-quality analytics and corpus operators as Spark DataFrame functions."""
