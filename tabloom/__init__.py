"""tabloom: specification-driven synthetic tables, learning, validation and scoring on Spark."""

from tabloom.spec import FieldSpec, TableSpec

__all__ = ["FieldSpec", "TableSpec"]
