"""The registered operations; importing this registers all of them."""

from . import aggregate, alignment, anomaly, arithmetics, correlation, data_frame, gapfilling, normalize, outliers, plotdata, regions, resampling, select, subset, timeseries, utility

__all__ = ["aggregate", "alignment", "anomaly", "arithmetics", "correlation", "data_frame", "gapfilling", "normalize", "outliers", "plotdata", "regions", "resampling", "select", "subset", "timeseries", "utility"]
