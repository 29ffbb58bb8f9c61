"""flowsentry: network-flow threat analytics on Spark DataFrames.

Entry points: :func:`flowsentry.plans.analyze.analyze` (the whole run on one
flow table), :mod:`flowsentry.sources.flowcsv` (CSV ingest),
:class:`flowsentry.sources.ledger.RunLedger` (run and alert store).
"""

__version__ = "0.1.0"
