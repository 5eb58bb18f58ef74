"""The data model: edge lists as matrices, node tables, and what goes with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TILE_ROWS, TILE_COLS = 16, 8

EDGES = "src bigint, dst bigint, weight float"
NODES = "node_id bigint, features array<float>, label bigint, split string"
PARTITIONS = "part_id int, start_idx bigint, end_idx bigint, real_count bigint, pad_count bigint"


@dataclass(frozen=True)
class GraphMeta:
    """Sizes of a sparse matrix: row = src, column = dst."""

    num_rows: int
    num_cols: int
    tile_rows: int = TILE_ROWS
    tile_cols: int = TILE_COLS

    @property
    def num_windows(self) -> int:
        return -(-self.num_rows // self.tile_rows)

    @property
    def padded_rows(self) -> int:
        return self.num_windows * self.tile_rows


@dataclass(frozen=True)
class GraphBundle:
    """A graph with its nodes; both lazy."""

    edges: DataFrame
    nodes: DataFrame
    meta: GraphMeta
    num_classes: int = 0
    multi_label: bool = False


@dataclass(frozen=True)
class HacsOptions:
    """Weights of the column score that favours important columns, and those in the window's own part."""

    alpha: float = 1.0
    beta: float = 10.0
    delta: float = 0.0
    gamma_bonus: float = 0.0
    score_scale: float = 100.0
    q_min: float = 0.5
    q_max: float = 2.0
    eps: float = 1e-6
    enabled: bool = True

    @classmethod
    def from_config(cls, config: dict) -> HacsOptions:
        """From the key HACS or hacs at the top, else DPS.HACS; unknown keys are ignored."""
        own = config.get("HACS") or config.get("hacs") or (config.get("DPS") or {}).get("HACS") or {}
        return cls(**{k: own[k] for k in cls.__dataclass_fields__ if k in own})


@dataclass(frozen=True)
class Subgraph:
    """One sampled layer, or a cut-out: edges in local or global ids, and the tables that explain them."""

    edges: DataFrame
    nodes: DataFrame
    n_internal: int | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
