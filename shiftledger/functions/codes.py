"""Fixed project codes and classes, and the expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes and names below are part of the data contract.
BILLABLE = "billable"
NONBILLABLE = "nonbillable"
UNAVAILABLE = "unavailable"
ABSENCE_REASONS = ("FER1000", "SYK1000", "SYK1001", "SYK1002", "PER1000", "PER1001", "PER1002", "FAG1000", "AVS")
TIME_OFF_IN_LIEU = ("AVS", "Avspasering", NONBILLABLE)
VACATION = "FER1000"
SELF_REPORTED_SICK = "SYK1000"
SICK_CHILD = "SYK1002"
PROFESSIONAL_DEVELOPMENT = "FAG1000"
BONUS_PROJECTS = ("PER1005", "REK1010")
HOURS_PER_DAY = 7.5

# Code point ranges that an emoji may start with.
EMOJI_RANGES = (
    (128, 687), (768, 1023), (1536, 1791), (3072, 3199), (7616, 7679), (7680, 7935), (8192, 8351),
    (8400, 8527), (8592, 9215), (9312, 9727), (9728, 10223), (10496, 10751), (11008, 11263),
    (11360, 11391), (11776, 11903), (12288, 12351), (42128, 42191), (57344, 63743), (65024, 65039),
    (65072, 65103), (126976, 127023), (127136, 127231), (127232, 128591), (128640, 128767),
    (129296, 129387), (129408, 129504),
)


def is_absence_reason(code: Column) -> Column:
    return code.isin(*ABSENCE_REASONS)


def class_from_flag(billable: Column) -> Column:
    """Old boolean flag to class name; a missing flag counts as not billable."""
    return F.when(billable, F.lit(BILLABLE)).otherwise(F.lit(NONBILLABLE))


def flag_from_class(billable: Column) -> Column:
    return billable.eqNullSafe(F.lit(BILLABLE))


def is_emoji(value: Column) -> Column:
    """At most ten characters, one of them at most (splitting at optional whitespace gives one piece),
    starting in one of the ranges. NULL passes, as it does for any column rule."""
    in_range = F.lit(False)
    for low, high in EMOJI_RANGES:
        in_range = in_range | F.ascii(value).between(low, high)
    return value.isNull() | ((F.length(value) == 1) & in_range)
