"""Clustering of very large point tables by sampling and pruning, as Spark DataFrame jobs."""

from .estimator import PrunedKMeans, PrunedKMeansModel
from .functions.centers import Centers
from .plans.kmeans_parallel import kmeans_parallel
from .plans.sample_prune import sample_prune
from .plans.sampled_kmeans import sampled_kmeans

__all__ = ["Centers", "PrunedKMeans", "PrunedKMeansModel", "kmeans_parallel", "sample_prune", "sampled_kmeans"]
