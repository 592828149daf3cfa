"""Text-robustness analytics over Spark DataFrames.

``functions``  Column -> Column building blocks (native expressions only)
``operators``  DataFrame -> DataFrame steps: sampling, joins, perturbation, metrics, rewards
``sources``    readers, writers and shared scratch storage
``plans``      whole jobs composed from the operators
"""
