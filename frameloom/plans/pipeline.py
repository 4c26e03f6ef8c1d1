"""A pipeline is a source and a list of specs; ``build`` makes the DataFrame.

Column pruning, predicate push-down and join order are Catalyst's. The rewrites
here act on specs, because they trade accuracy for pixels and so are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from frameloom.operators import events, maps


@dataclass(frozen=True)
class Op:
    """One step: name, arguments, and how it is applied."""

    name: str
    args: dict = field(default_factory=dict)
    apply: Callable[..., DataFrame] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        f = self.apply or REGISTRY[self.name]
        return f(df, **self.args)


@dataclass(frozen=True)
class Metric(Op):
    """A counted region: args name, region, label."""


def _metric(df, name, region, label="object"):
    return events.activity_metric(df, name, region, label)


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "crop": maps.crop, "mask": maps.mask, "gc": maps.gc, "resize": maps.resize, "grayscale": maps.grayscale, "blur": maps.blur, "canny": maps.canny,
    "keypoint_filter": maps.keypoint_filter, "metric": _metric, "filter": events.event_filter, "null": maps.null,
}


@dataclass(frozen=True)
class Pipeline:
    """``Pipeline()[Op('crop', {...})][Metric('metric', {...})]``: lineage is ``ops``."""

    ops: tuple[Op, ...] = ()

    def __getitem__(self, op: Op) -> Pipeline:
        return replace(self, ops=(*self.ops, op))

    def build(self, source: DataFrame) -> DataFrame:
        validate(self)
        for op in self.ops:
            source = source.transform(op)
        return source

    def optimize(self, *rules: Callable[[Pipeline], Pipeline]) -> Pipeline:
        out = self
        for rule in rules:
            out = rule(out)
        return out

    def metrics(self) -> dict[str, Op]:
        return {o.args["name"]: o for o in self.ops if o.name == "metric"}

    def filters(self) -> dict[str, Op]:
        return {o.args["metric"]: o for o in self.ops if o.name == "filter"}


def validate(p: Pipeline) -> None:
    """A filter needs its metric before it."""
    known: set[str] = set()
    for o in p.ops:
        if o.name == "metric":
            known.add(o.args["name"])
        if o.name == "filter" and o.args["metric"] not in known:
            raise ValueError(f"filter on {o.args['metric']!r}, which no earlier metric defines")


def multi_metric_region(p: Pipeline, factor: float = 1.1) -> tuple[int, int, int, int] | None:
    """Box around the regions of all metrics, each stretched by ``factor``."""
    boxes = [o.args["region"] for o in p.ops if o.name == "metric"]
    if not boxes:
        return None
    return min(int(b[0] / factor) for b in boxes), min(int(b[1] / factor) for b in boxes), max(int(b[2] * factor) for b in boxes), max(int(b[3] * factor) for b in boxes)


def crop_push_down(p: Pipeline, use: str = "crop") -> Pipeline:
    """Crop (or mask) to the regions of all metrics right after the source."""
    region = multi_metric_region(p)
    if region is None or any(o.name in ("crop", "mask") for o in p.ops):
        return p
    first = Op(use, dict(zip(("x0", "y0", "x1", "y1"), region, strict=True)))
    return replace(p, ops=(first, *p.ops))


def drop_pixels(p: Pipeline) -> Pipeline:
    """Pixels go once nothing later needs them."""
    users = {"crop", "mask", "resize", "grayscale", "blur", "canny"}
    last = max((i for i, o in enumerate(p.ops) if o.name in users or o.apply is not None), default=-1)
    if any(o.name == "gc" for o in p.ops):
        return p
    return replace(p, ops=(*p.ops[: last + 1], Op("gc"), *p.ops[last + 1 :]))


def adaptive_blur(bitrate: float, reference: float = 1_000_000.0, base: int = 5) -> int:
    """Nearest odd kernel in 1..31 to one that shrinks with the bitrate."""
    want = base * max(bitrate, 1.0) / reference
    return min(range(1, 32, 2), key=lambda k: (abs(k - want), k))


def size_estimate(width: int, height: int, frames: int, channels: int = 3) -> int:
    return width * height * frames * channels
