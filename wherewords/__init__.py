"""Where a short message was written: text geolocation as Spark DataFrame jobs.

Every operator takes DataFrames and gives a DataFrame. See the sub-packages:

``sources``    readers, writers, dimensions, saved models
``functions``  Column expressions (text, scalars, aggregates)
``operators``  row, join, aggregate, window, feature, region and cluster operators
``plans``      the end-to-end jobs: geolocation, stacked ensemble, retrieval, tuning
``streaming``  capture of message streams
"""

__version__ = "0.1.0"
