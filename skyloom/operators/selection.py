"""Region and mask selection compiled to boolean columns over pixel coordinates ``l`` (x) and ``m`` (y)."""

from __future__ import annotations

import ast
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PIXELS = {"pix": 1.0}
_ANGLES = {"deg": math.pi / 180, "rad": 1.0, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000}
_SHAPE = re.compile(r"^\s*(?P<sign>[+-])?\s*(?P<shape>[a-z]+)\s*(?P<args>\[.*\])\s*(?P<rest>.*)$", re.I)


def _xy() -> tuple[Column, Column]:
    return F.col("l").cast("double"), F.col("m").cast("double")


def box(x0: float, y0: float, x1: float, y1: float) -> Column:
    x, y = _xy()
    return x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))


def centerbox(cx: float, cy: float, w: float, h: float) -> Column:
    x, y = _xy()
    return (F.abs(x - cx) <= w / 2) & (F.abs(y - cy) <= h / 2)


def rotbox(cx: float, cy: float, w: float, h: float, theta: float) -> Column:
    x, y = _xy()
    c, s = math.cos(theta), math.sin(theta)
    return (F.abs((x - cx) * c + (y - cy) * s) <= w / 2) & (F.abs((y - cy) * c - (x - cx) * s) <= h / 2)


def _r2(cx: float, cy: float) -> Column:
    x, y = _xy()
    return (x - cx) * (x - cx) + (y - cy) * (y - cy)


def circle(cx: float, cy: float, r: float) -> Column:
    return _r2(cx, cy) <= r * r + 1e-9


def annulus(cx: float, cy: float, r0: float, r1: float) -> Column:
    return _r2(cx, cy).between(r0 * r0, r1 * r1)


def ellipse(cx: float, cy: float, a: float, b: float, theta: float) -> Column:
    x, y = _xy()
    c, s = math.cos(theta), math.sin(theta)
    u, v = ((x - cx) * c + (y - cy) * s) / a, ((y - cy) * c - (x - cx) * s) / b
    return u * u + v * v <= 1 + 1e-9


def poly(points: list[tuple[float, float]]) -> Column:
    """Even-odd rule: each edge that a ray to the right crosses flips the state."""
    x, y = _xy()
    inside = F.lit(False)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
        if y0 == y1:
            continue
        crosses = (F.lit(y0) > y) != (F.lit(y1) > y)
        inside = inside != (crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0))
    return inside


def _value(text: str, units: dict[str, float]) -> float:
    m = re.fullmatch(rf"\s*({_NUMBER})\s*([a-z]*)\s*", text)
    if not m:
        raise ValueError(f"{text.strip()!r} is no number with a unit; try 10{next(iter(units))}")
    if m[2] not in units:
        raise ValueError(f"{text.strip()!r} needs a unit of {sorted(units)}; try {m[1]}{next(iter(units))}")
    return float(m[1]) * units[m[2]]


def _angle(rest: str, needed: bool) -> float:
    found = dict(re.findall(r"\b(pa|theta_m)\s*=\s*([^,\s]+)", rest))
    if not found:
        if needed:
            raise ValueError("the shape needs an angle, as pa=30deg or theta_m=30deg")
        return 0.0
    if "theta_m" in found:
        return _value(found["theta_m"], _ANGLES)
    return math.pi / 2 - _value(found["pa"], _ANGLES)


def _shape(shape: str, args: str, rest: str) -> Column:
    numbers = [_value(x, _PIXELS) for x in re.sub(r"[\[\]]", " ", args).split(",")]
    counts = {"box": 4, "centerbox": 4, "rotbox": 4, "circle": 3, "annulus": 4, "ellipse": 4}
    if shape == "poly":
        if len(numbers) < 6 or len(numbers) % 2:
            raise ValueError("a polygon has three corners or more")
        return poly(list(zip(numbers[::2], numbers[1::2])))
    if shape not in counts:
        raise ValueError(f"unknown shape {shape!r}; known are {sorted([*counts, 'poly'])}")
    if len(numbers) != counts[shape]:
        raise ValueError(f"{shape} takes {counts[shape]} numbers")
    if shape == "rotbox":
        # The trailing angle follows the numbers, or stands as a keyword.
        return rotbox(*numbers, _angle(rest, True))
    if shape == "ellipse":
        return ellipse(*numbers, _angle(rest, False))
    return {"box": box, "centerbox": centerbox, "circle": circle, "annulus": annulus}[shape](*numbers)


def crtf(text: str) -> Column:
    """Lines of shapes, folded from the first, beginning with nothing: ``+`` (the default) joins, ``-`` takes away."""
    out = None
    for line in re.split(r"[\n;]", text):
        line = line.strip()
        if not line or line.startswith("#") or line.lower().startswith("global"):
            continue
        m = _SHAPE.match(line)
        if not m:
            raise ValueError(f"{line!r} is no region; try circle[[10pix,10pix],5pix]")
        region = _shape(m["shape"].lower(), m["args"], m["rest"])
        if m["sign"] == "-":
            out = (out if out is not None else F.lit(False)) & ~region
        else:
            out = region if out is None else out | region
    if out is None:
        raise ValueError("no region in the text")
    return out


def _holds(mask: Column) -> Column:
    """A mask of any number type: true where it is not 0; NaN and null are false. Text that is no number raises."""
    value = mask.cast("double")
    return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))


def expression(text: str, masks: dict[str, Column]) -> Column:
    """``&``, ``|``, ``^``, ``~``, parentheses, True and False over named masks; NaN and null count as false."""

    def visit(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return visit(node.body)
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            a, b = visit(node.left), visit(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b if isinstance(node.op, ast.BitOr) else a != b
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
            return ~visit(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in masks:
                raise NameError(f"no mask {node.id!r}; there are {sorted(masks)}")
            return _holds(masks[node.id])
        raise ValueError("only &, |, ^, ~, parentheses, True, False and names are known; not and, or, not")

    return visit(ast.parse(text.strip(), mode="eval"))


def select_mask(select: object, masks: dict[str, Column] | None = None) -> Column:
    """Nothing selects all; a column is taken as it is; a path or back-ticked name is read; text is CRTF or an expression."""
    if select is None:
        return F.lit(True)
    if isinstance(select, Column):
        return _holds(select)
    if isinstance(select, Path):
        return crtf(select.read_text())
    if isinstance(select, str):
        if select.startswith("`") and select.endswith("`"):
            return crtf(Path(select[1:-1]).read_text())
        return crtf(select) if re.search(r"[a-z]+\s*\[", select) else expression(select, masks or {})
    raise TypeError(f"cannot select by {type(select).__name__}")


def apply_select(img: DataFrame, mask: Column | DataFrame) -> DataFrame:
    """NaN outside the mask: a column, or a table ``mask`` by pixel (``l, m``, and ``plane, chan`` where it has them), in
    which pixels without a row are outside."""
    if isinstance(mask, DataFrame):
        keys = [c for c in ("plane", "chan", "l", "m") if c in mask.columns and c in img.columns]
        inside = mask.where(_holds(F.col("mask"))).select(*keys).distinct().withColumn("inside", F.lit(True))
        wide = img.join(inside, keys, "left")
        return wide.withColumn("value", F.when(F.col("inside"), F.col("value").cast("double")).otherwise(NAN)).select(img.columns)
    return img.withColumn("value", F.when(mask, F.col("value").cast("double")).otherwise(NAN))


def combine_with_creation(a: tuple[Column, str], op: str, b: tuple[Column, str]) -> tuple[Column, str]:
    """Two masks and how they came about, combined."""
    ops = {"&": lambda x, y: x & y, "|": lambda x, y: x | y, "^": lambda x, y: x != y, "-": lambda x, y: x & ~y}
    if op not in ops:
        raise ValueError(f"unknown operator {op!r}; known are {sorted(ops)}")
    return ops[op](a[0], b[0]), f"({a[1]}) {op} ({b[1]})"
