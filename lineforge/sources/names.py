"""File names, readable numbers, and timing as the record tools print them."""

from __future__ import annotations

import contextlib
import resource
import time
from collections.abc import Callable, Iterator


def folder_of(path: str) -> str:
    """The folder of a path, ``.`` where it names none."""
    return path.rsplit("/", 1)[0] or "/" if "/" in path else "."


def root_of(path: str, suffix: str | None = None) -> str:
    """The last name of a path without ``suffix``, or without any suffix where none is given."""
    name = path.rsplit("/", 1)[-1]
    if suffix is not None:
        return name.removesuffix(suffix)
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


def joined(path: str, sep: str, root: str, suffix: str) -> str:
    return path + sep + root + suffix


def numbered_name(left: str, n: int, right: str) -> str:
    """A name with a part number; negative numbers give none."""
    return left + right if n < 0 else f"{left}{n}{right}"


def readable(n: int, width: int = 0) -> str:
    """A number with commas every three digits, right-aligned to ``width``."""
    return f"{n:,}".rjust(width)


def digits(n: int) -> int:
    """Decimal digits of a number, commas not counted."""
    return len(str(abs(n)))


@contextlib.contextmanager
def timed(report: Callable[[str], None] = print) -> Iterator[None]:
    """Report the wall, user and system seconds and the largest memory of what runs inside."""
    wall, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF)
    yield
    now = resource.getrusage(resource.RUSAGE_SELF)
    report(f"wall {time.perf_counter() - wall:.3f} s, user {now.ru_utime - before.ru_utime:.6f} s, system {now.ru_stime - before.ru_stime:.6f} s, largest {readable(now.ru_maxrss)} kB")
