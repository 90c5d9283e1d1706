"""Statistical learning as Spark DataFrame jobs.

Every fit is a handful of aggregate jobs, every score is a projection or a
size-checked lookup, and only fitted parameters reach the driver.
"""

import sys

from pyspark import cloudpickle

from statloom.plans.gaussian import GaussianClassifier, GaussianModel, fit_gaussian
from statloom.plans.histogram import HistogramModel, MultidimensionalHistogram, fit_histogram
from statloom.plans.kmeans import KMeans, KMeansModel
from statloom.plans.linear_regression import LinearModel, LinearRegression, fit_linear
from statloom.plans.tree import DecisionTreeClassifier, TreeModel, grow_tree

# Batch functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MDH = MultidimensionalHistogram

__all__ = [
    "DecisionTreeClassifier",
    "GaussianClassifier",
    "GaussianModel",
    "HistogramModel",
    "KMeans",
    "KMeansModel",
    "LinearModel",
    "LinearRegression",
    "MDH",
    "MultidimensionalHistogram",
    "TreeModel",
    "fit_gaussian",
    "fit_histogram",
    "fit_linear",
    "grow_tree",
]
