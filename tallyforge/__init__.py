"""tallyforge: schedule text to audited, reconciled take-off tables, as Spark DataFrame transforms."""

__version__ = "0.1.0"
