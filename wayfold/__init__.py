"""Sensor-trajectory analytics on Spark: temporal, spatial, voxel, estimator and evaluation operators."""
