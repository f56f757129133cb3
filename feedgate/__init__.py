"""Release, merge and republish document collections with Spark."""

from feedgate.spec import CollectionSpec, FieldSpec, SpecError, SpecSet

__all__ = ["CollectionSpec", "FieldSpec", "SpecError", "SpecSet"]
