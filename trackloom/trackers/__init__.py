"""Multi-object trackers as grouped maps over (sequence) with NumPy kernels."""
