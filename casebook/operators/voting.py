"""Expressions over class-probability arrays (classes in ascending order)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def soft_vote(p: Column, q: Column) -> Column:
    """The mean of two probability arrays."""
    return F.zip_with(p, q, lambda a, b: (a + b) / 2.0)


def argmax_label(p: Column, classes: Column) -> Column:
    """The class of the largest probability, the first one on ties."""
    return F.element_at(classes, F.array_position(p, F.array_max(p)).cast("int"))


def confidence(p: Column) -> Column:
    return F.array_max(p)


def joint_confidence(p1: Column, p2: Column) -> Column:
    """Level-1 confidence times level-2 confidence."""
    return F.array_max(p1) * F.array_max(p2)
