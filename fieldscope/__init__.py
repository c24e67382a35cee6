"""fieldscope: field-operations analytics and corpus preparation as Spark jobs."""
