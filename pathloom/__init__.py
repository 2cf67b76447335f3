"""Search over package file manifests, written for PySpark."""
