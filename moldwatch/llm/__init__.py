"""Operators of a training-data pipeline: packing, token counts, decontamination,
language ID, licence scans, near duplicates, LM scoring, quality rules, chat
formatting, toxicity, neighbour search, resampling and whitening.  Nothing else in the library imports this package."""
import sys

from pyspark import cloudpickle

# Functions of this package go to the executors by value: no copy of it has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
