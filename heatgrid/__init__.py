"""heatgrid: PySpark operators for urban surface-heat features, scoring and cooling plans."""

__version__ = "0.1.0"
