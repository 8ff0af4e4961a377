"""tabloom: labelled tables to instruction-tuning examples, and scoring of the
predictions that come back, as Spark DataFrame jobs."""

from tabloom.spec import EXAMPLE_SCHEMA, LabelMap, PrepSpec

__all__ = ["EXAMPLE_SCHEMA", "LabelMap", "PrepSpec"]
