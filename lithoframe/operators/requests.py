"""What a user types, as numbers: boxes, places, views, error lists; and how much a round of a stream may bring."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20
#: Bytes of a round at least and at most; rounds of a view, the last of which takes all that is left.
LEAST_ROUND, MOST_ROUND, ROUNDS = 2 * MIB, 32 * MIB, 8


def _numbers(text: str) -> list[float]:
    try:
        return [float(t) for t in text.replace(",", " ").split()]
    except ValueError:
        raise ValueError(f"{text!r} is not a list of numbers") from None


def box_in_dbu(text: str, dbu: float) -> tuple[int, int, int, int]:
    """X0,Y0,X1,Y1 in micrometres as whole units, nearest (halves to even) and in order; an empty box is an error."""
    v = _numbers(text)
    if len(v) != 4:
        raise ValueError(f"{text!r} is no box X0,Y0,X1,Y1")
    (x0, x1), (y0, y1) = (sorted(round(a / dbu) for a in v[k::2]) for k in (0, 1))
    if x0 == x1 or y0 == y1:
        raise ValueError(f"the box {text!r} is empty")
    return x0, y0, x1, y1


def place(text: str) -> list[float]:
    """X,Y or X,Y,WINDOW in micrometres; a window is above 0."""
    v = _numbers(text)
    if len(v) not in (2, 3) or v[2:] and v[2] <= 0:
        raise ValueError(f"{text!r} is no place X,Y[,WINDOW]")
    return v


@dataclass(frozen=True)
class View:
    box: tuple[int, int, int, int]
    cut: int
    px_per_dbu: float


def view_of(um: tuple[float, float, float, float], unit: float, px_per_um: float, cut_px: float) -> View:
    """A view in units, cut short towards 0; shapes below cut_px pixels are smaller than `cut`."""
    return View(tuple(int(v * unit) for v in um), int(cut_px / px_per_um * unit), px_per_um / unit)


def error_numbers(text: str, n: int) -> tuple[int, int]:
    """N, A-B or all of n errors, as the first and last number; a range is cut to what is there, none is an error."""
    if text.strip().lower() == "all":
        first, last = 1, n
    else:
        a, dash, b = text.partition("-")
        if not a.strip().isdigit() or dash and not b.strip().isdigit():
            raise ValueError(f"{text!r} is no list of errors")
        first = int(a)
        last = int(b) if dash else first
    if first < 1 or first > n or last < first:
        raise ValueError(f"{text!r} names none of {n} errors")
    return first, min(last, n)


class Rounds:
    """The budget of a view's rounds: it follows the bytes a second that full rounds have reached."""

    def __init__(self, budget: int = 4 * MIB, seconds: float = 0.5):
        self.budget, self.seconds, self.done = budget, seconds, 0

    def next(self) -> int:
        """Bytes that the next round may bring; 0, no limit, for the last."""
        return 0 if self.done + 1 >= ROUNDS else self.budget

    def ended(self, brought: int, took: float) -> None:
        """A round that brought at least half its budget tells the speed; others say nothing."""
        self.done += 1
        if took > 0 and 2 * brought >= self.budget:
            self.budget = min(MOST_ROUND, max(LEAST_ROUND, int(brought / took * self.seconds)))
