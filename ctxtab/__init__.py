"""ctxtab: a PySpark engine for labelled tables.

Cleans and encodes feature columns, rebalances and scales their
distributions, splits rows, retrieves the most relevant training rows for
every test row, predicts from that context, ensembles pipeline variants and
reports metrics over suites of datasets.  Everything is a DataFrame keyed by
``row_id`` (and optionally ``dataset_id``); fitted statistics are gathered
in single aggregation passes and only statistics reach the driver.
"""

__version__ = "0.1.0"
