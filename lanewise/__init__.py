"""Shipment analytics as Spark DataFrame operators.

Every operator has the form ``op(frame, by=("upload_id",), **params) -> DataFrame``.
``by`` names the columns that identify a dataset, so one job reports on any
number of datasets at once; ``by=()`` treats the whole frame as one dataset.
"""
