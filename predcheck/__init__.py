"""Predictive checks on Spark: binned observed quantiles against the spread of simulated replicates."""

import sys

from pyspark import cloudpickle

from .functions.quantiles import grouped_quantiles
from .operators.align import check_order, cyclic_label, dense_index, from_replicate, order_report, spread_over_replicates
from .operators.binning import BinModel, BinRule, assign_bins, fit_bins
from .operators.prepare import derive, keep_records, natural_left_join
from .operators.report import report
from .operators.states import Mergeable
from .plans.spec import VPC, observed
from .sources.readers import read_table, store_replicates, write_table

# Functions sent to Python workers travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["VPC", "BinModel", "BinRule", "Mergeable", "assign_bins", "check_order", "cyclic_label", "dense_index", "derive", "fit_bins",
           "from_replicate", "grouped_quantiles", "keep_records", "natural_left_join", "observed", "order_report", "read_table",
           "report", "spread_over_replicates", "store_replicates", "write_table"]
