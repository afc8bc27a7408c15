"""claimscope: a PySpark engine for evaluating automatically built knowledge bases."""
