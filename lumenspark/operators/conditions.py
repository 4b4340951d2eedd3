"""Experiment conditions: one knob each, or several folded into one severity; parsed from and written to records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from typing import Any

from lumenspark.functions.identity import canonical_sha256
from lumenspark.operators.frames import Severity

#: The order in which mechanisms act, and the families of comparators.
ORDER = ("physical_defocus", "rolling_rotation", "photon_loss", "tone_stop_ratio")
COMPARATORS = ("gaussian", "quadratic_cosine", "sampled_incoherent")


@dataclass(frozen=True)
class Binding:
    """What every condition belongs to: a camera profile, a way of forming images, and ordered realizations."""

    profile_sha256: str
    mode: str = "ldr"
    realizations: tuple[int, ...] = (0,)

    def __post_init__(self) -> None:
        if self.mode not in ("ldr", "forward") or not self.realizations or len(set(self.realizations)) != len(self.realizations):
            raise ValueError("a binding has a known mode and different realizations, one at least")


@dataclass(frozen=True)
class Condition:
    """``family`` says which of the values means something; a factorial condition has several parts in physical order."""

    binding: Binding
    family: str
    value: float | None = None
    kind: str | None = None
    parts: tuple[Condition, ...] = ()

    def __post_init__(self) -> None:
        match self.family:
            case "baseline":
                good = self.kind in ("untouched_input", "modeled_neutral") and self.value is None and not self.parts
            case "mechanism_comparator":
                good = self.kind in COMPARATORS and self.value is not None and self.value >= 0 and not self.parts
            case "factorial":
                names = [p.family for p in self.parts]
                good = len(names) > 1 and sorted(set(names), key=ORDER.index) == names and all(p.binding == self.binding for p in self.parts)
            case _:
                good = self.family in ORDER and self.value is not None and not self.parts
        if not good or (self.value is not None and self.value != self.value):
            raise ValueError(f"not a {self.family} condition")

    def record(self) -> dict[str, Any]:
        return {"record_type": "condition", "binding": {**asdict(self.binding), "realizations": list(self.binding.realizations)}, "family": self.family, "value": self.value, "kind": self.kind, "parts": [p.record() for p in self.parts]}

    @property
    def sha256(self) -> str:
        return canonical_sha256(self.record())

    def severity(self) -> Severity | None:
        """One record of how the image is made worse; None for an image that isn't touched."""
        if self.kind == "untouched_input":
            return None
        out: dict[str, Any] = {}
        for part in self.parts or (self,):
            match part.family:
                case "physical_defocus":
                    out["waves"] = part.value
                case "photon_loss":
                    out["stops"] = part.value
                    out["through_sensor"] = True
                case "mechanism_comparator":
                    out["comparator"] = (part.kind, part.value)
                case "rolling_rotation":  # radians a second about the vertical axis
                    out["rotation"] = (0.0, part.value, 0.0)
                case "tone_stop_ratio":
                    out["tone"] = part.value
        return Severity(**out)


def parsed(record: dict[str, Any]) -> Condition:
    """The condition of a record; unknown or missing fields are errors."""
    wanted = {"record_type", "binding", "family", "value", "kind", "parts"}
    if set(record) != wanted or record["record_type"] != "condition" or set(record["binding"]) != {f.name for f in fields(Binding)}:
        raise ValueError("not a condition record")
    binding = Binding(**{**record["binding"], "realizations": tuple(record["binding"]["realizations"])})
    return Condition(binding, record["family"], record["value"], record["kind"], tuple(map(parsed, record["parts"])))


def parse_grid(text: str, kind: type = float, low: float = -float("inf"), high: float = float("inf")) -> tuple:
    """Comma-joined different numbers, finite and within the bounds, in the order given."""
    values = tuple(kind(x) for x in text.split(","))
    if len(set(values)) != len(values) or any(not low <= v <= high or v != v or v in (float("inf"), -float("inf")) for v in values):
        raise ValueError(f"{text!r} is not a grid")
    return values
