"""Table operators for noisy measurements, as DataFrame-to-DataFrame functions on Spark."""
