"""Column families: which names are scalars, which are profiles of `levels` numbered columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ProfileSchema:
    """Names of a wide sample table. A family `f` stands for `f_0 .. f_<levels-1>`."""

    in_scalars: tuple[str, ...]
    in_families: tuple[str, ...]
    out_scalars: tuple[str, ...]
    out_families: tuple[str, ...]
    levels: int
    aux: tuple[str, ...] = ("location", "lat", "lon", "year", "month", "hour", "day")
    id_col: str = "sample_id"

    @property
    def families(self) -> tuple[str, ...]:
        return self.in_families + self.out_families

    def expand(self, names: Iterable[str]) -> list[str]:
        """Flat column names: scalars as they are, families level by level."""
        flat: list[str] = []
        for name in names:
            if name in self.families:
                flat += [f"{name}_{i}" for i in range(self.levels)]
            else:
                flat.append(name)
        return flat

    @property
    def input_columns(self) -> list[str]:
        return self.expand(self.in_scalars + self.in_families)

    @property
    def label_columns(self) -> list[str]:
        return self.expand(self.out_scalars + self.out_families)

    def raw_struct(self, labels: bool = True) -> T.StructType:
        """Explicit schema of the raw CSV, so that reading it needs no inference pass."""
        names = self.input_columns + (self.label_columns if labels else [])
        return T.StructType(
            [T.StructField(self.id_col, T.StringType())]
            + [T.StructField(name, T.DoubleType()) for name in names]
        )

    def packed_columns(self, labels: bool = True) -> list[str]:
        """Column order of the processed table."""
        outputs = self.out_scalars + self.out_families if labels else ()
        return [self.id_col, *self.in_scalars, *self.in_families, *outputs, *self.aux]


# The column names of the atmospheric sample table, in file order.
ATMOSPHERE = ProfileSchema(
    in_scalars=(
        "state_ps", "pbuf_SOLIN", "pbuf_LHFLX", "pbuf_SHFLX", "pbuf_TAUX", "pbuf_TAUY",
        "pbuf_COSZRS", "cam_in_ALDIF", "cam_in_ALDIR", "cam_in_ASDIF", "cam_in_ASDIR",
        "cam_in_LWUP", "cam_in_ICEFRAC", "cam_in_LANDFRAC", "cam_in_OCNFRAC",
        "cam_in_SNOWHLAND",
    ),
    in_families=(
        "state_t", "state_q0001", "state_q0002", "state_q0003", "state_u", "state_v",
        "pbuf_ozone", "pbuf_CH4", "pbuf_N2O",
    ),
    out_scalars=(
        "cam_out_NETSW", "cam_out_FLWDS", "cam_out_PRECSC", "cam_out_PRECC",
        "cam_out_SOLS", "cam_out_SOLL", "cam_out_SOLSD", "cam_out_SOLLD",
    ),
    out_families=(
        "ptend_t", "ptend_q0001", "ptend_q0002", "ptend_q0003", "ptend_u", "ptend_v",
    ),
    levels=60,
)

# Lookup key, samples per year of the id numbering, year of the test rows.
LOOKUP_KEY = "pbuf_ozone_2"
SAMPLES_PER_YEAR = 1441646
TEST_YEAR = 7
# Digits and time slots of the fallback lookups.
FALLBACK_DIGITS = (18, 15)
FALLBACK_HOURS = (0, 8, 16)
# Outputs that cannot be negative.
NON_NEGATIVE = (
    "cam_out_NETSW", "cam_out_PRECSC", "cam_out_PRECC", "cam_out_SOLS", "cam_out_SOLL",
    "cam_out_SOLSD", "cam_out_SOLLD",
)
# Outputs that follow from an input, output = -input / 1200 (levels 0 to 27),
# and the levels that are left out of training.
CLOSED_FORM_DIVISOR = 1200.0
CLOSED_FORM = {f"ptend_q0002_{i}": f"state_q0002_{i}" for i in range(28)}
UNUSED_LABELS = tuple(f"ptend_q0002_{i}" for i in range(12, 28))


def family_columns(columns: Iterable[str], family: str) -> list[str]:
    """The columns `family_<number>`, in order of the number whatever the input order."""
    pattern = re.compile(rf"{re.escape(family)}_(\d+)")
    found = [(int(m.group(1)), c) for c in columns if (m := pattern.fullmatch(c))]
    return [name for _, name in sorted(found)]


def resolve_targets(columns: Sequence[str], names: Iterable[str]) -> list[str]:
    """Existing names stay, others stand for their family; names with neither vanish."""
    present = set(columns)
    targets: list[str] = []
    for name in names:
        targets += [name] if name in present else family_columns(columns, name)
    return targets


def natural_key(name: Column) -> list[Column]:
    """Sort keys that put `a_2` before `a_10`: text before the last number, then the number."""
    prefix = F.regexp_replace(name, r"\d+$", "")
    number = F.regexp_extract(name, r"(\d+)$", 1).try_cast("bigint")
    return [prefix, number]
