"""Training-data operators: each module holds one operator and its query.

Nothing outside this package imports it; ``registry`` lists the queries for
the driver's entry module.
"""
