"""Raw words to physical units, bits and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Scales of the recording formats.
AMPLIFIER_UV, AUX_V, SUPPLY_V, TEMPERATURE_C, DC_V = 0.195, 37.4e-6, 74.8e-6, 0.01, -0.01923
ADC_V, ADC_USB3_V, ADC_PLAIN_V = 152.59e-6, 312.5e-6, 50.354e-6


def amplifier_uv(word: Column) -> Column:
    return (word - 32768) * AMPLIFIER_UV


def auxiliary_v(word: Column) -> Column:
    return word * AUX_V


def supply_v(word: Column) -> Column:
    return word * SUPPLY_V


def temperature_c(word: Column) -> Column:
    return word * TEMPERATURE_C


def adc_v(word: Column, board_mode: Column) -> Column:
    return F.when(board_mode == 1, (word - 32768) * ADC_V).when(board_mode == 13, (word - 32768) * ADC_USB3_V).otherwise(word * ADC_PLAIN_V)


def stim_adc_v(word: Column) -> Column:
    """ADC and DAC of the stimulation format."""
    return (word - 32768) * ADC_USB3_V


def dc_v(word: Column) -> Column:
    return (word - 512) * DC_V


def digital(word: Column, native_order: Column | int) -> Column:
    return F.getbit(word, F.lit(native_order) if isinstance(native_order, int) else native_order) == 1


def stim_parts(word: Column) -> dict[str, Column]:
    bit = lambda k: F.getbit(word, F.lit(k))
    sign = 1 - 2 * bit(8).cast("int")
    return {"compliance": bit(15) == 1, "charge_recovery": bit(14) == 1, "amp_settle": bit(13) == 1, "stim": word.bitwiseAND(F.lit(255)) * sign}


def stim_ua(stim: Column, step_size: Column | float) -> Column:
    return stim * step_size / 1e-6


def timestamp_gaps(ticks: DataFrame, key: str = "recording", block: int = 1 << 18) -> DataFrame:
    """Number of steps other than 1 between consecutive ticks; block by block."""
    at = F.floor(F.col("n") / block)
    near = ticks.withColumn("block", F.explode(F.array_distinct(F.array(at, F.floor((F.col("n") + 1) / block))))).withColumn("own", F.col("block") == at)
    step = F.col("tick") - F.lag("tick").over(W.partitionBy(key, "block").orderBy("n"))
    return near.withColumn("step", step).filter("own").groupBy(key).agg(F.count_if((F.col("step") != 1)).alias("gaps"))


def seconds(tick: Column, fs_hz: float) -> Column:
    return tick / fs_hz


def subsampled(ticks: DataFrame, every: int) -> DataFrame:
    """The slower axes: every 4th tick for auxiliary inputs, one a block for supply and temperature."""
    return ticks.filter(F.col("n") % every == 0)
