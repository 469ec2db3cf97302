"""staffwise: workforce turnover analytics as Spark DataFrame plans.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected to the driver. See README.md for the map from
operator ids to modules.
"""

__version__ = "0.1.0"
