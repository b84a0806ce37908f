"""The manifest: the ordered list of live segments, oldest first, replaced as a whole by one rename."""

from __future__ import annotations

from lodestar.sources.files import Files
from lodestar.types import Status

# Fixed values of the file format.
MAGIC = "VECMAN01"
VERSION = 1
NAME = "MANIFEST"


def segment_name(number: int) -> str:
    return f"segment-{number:06d}.vec"


def segment_number(name: str) -> int:
    """The number in a segment's name; 0 if it has another form."""
    digits = name.removeprefix("segment-").removesuffix(".vec")
    return int(digits) if name == f"segment-{digits}.vec" and digits.isdigit() and digits.isascii() else 0


def next_segment(names: list[str]) -> str:
    """A name whose number no listed segment has or had after it."""
    return segment_name(max(map(segment_number, names), default=0) + 1)


def render(names: list[str]) -> bytes:
    return "".join(f"{line}\n" for line in (MAGIC, VERSION, len(names), *names)).encode()


def parse(data: bytes) -> list[str] | None:
    """The names in a manifest; None if it is malformed."""
    try:
        lines = data.decode().split("\n")
    except UnicodeDecodeError:
        return None
    if lines[-1] == "":
        lines.pop()
    head, names = lines[:3], lines[3:]
    if len(head) < 3 or head[0] != MAGIC or not all(x.isascii() and x.isdigit() for x in head[1:]):
        return None
    return names if int(head[1]) == VERSION and int(head[2]) == len(names) and all(names) else None


class Manifest:
    """The segments of a folder. Only what replace() published counts; drafts are never read."""

    def __init__(self) -> None:
        self._names: list[str] = []

    @property
    def segments(self) -> list[str]:
        return list(self._names)

    def add(self, name: str) -> None:
        self._names.append(name)

    def clear(self) -> None:
        self._names.clear()

    def load(self, files: Files, folder: str) -> Status:
        """Read the folder's manifest; without one the list is empty. A malformed one is an invalid_argument and changes nothing."""
        if not files.exists(f"{folder}/{NAME}"):
            self._names = []
            return Status.ok
        names = parse(files.read(f"{folder}/{NAME}"))
        if names is None:
            return Status.invalid_argument
        self._names = names
        return Status.ok

    def replace(self, files: Files, folder: str) -> Status:
        """Publish the list. A blank name, or one of several lines, is an invalid_argument and leaves the file alone."""
        if any(not name or "\n" in name for name in self._names):
            return Status.invalid_argument
        files.replace(f"{folder}/{NAME}", render(self._names))
        return Status.ok
