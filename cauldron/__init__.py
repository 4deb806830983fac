"""cauldron: causal uplift analytics and discount allocation on Spark.

Everything is expressed with the DataFrame / SQL API, Spark ML and Structured
Streaming.  Row data never passes through the driver; the only values the
driver handles are bounded: bucket edges of the distributed prefix sum, small
Gram matrices, fitted model coefficients and one-row metric frames.
"""

__version__ = "0.1.0"
