"""Values that fade with age, and penalties that are forgiven by the day."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS, PENALTY_PER_DAY = 30.0, 0.2


def age_days(created: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400e6)


def decayed(base: Column, created: Column, as_of: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    return base * F.pow(F.lit(0.5), age_days(created, as_of) / half_life)


def penalty_now(penalty: Column, days: Column) -> Column:
    return F.greatest(F.lit(0.0), penalty - PENALTY_PER_DAY * days)
