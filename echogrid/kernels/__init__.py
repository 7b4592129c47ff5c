"""NumPy kernels for what column expressions cannot do; no Spark in here."""
