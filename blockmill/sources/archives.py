"""Zip containers held in memory, with bounds on what they may unpack to."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from xml.parsers import expat

# The bounds on documents and archives.
MAX_DOCUMENT = 150 << 20
MAX_MEMBER = 300 << 20
MAX_ARCHIVE = 300 << 20
MAX_MEMBERS = 8192


class Rejected(Exception):
    """An input that cannot be taken; `code` is INVALID or UNSUPPORTED."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


def invalid(message: str) -> Rejected:
    return Rejected("INVALID", message)


class Archive:
    """Members by name, the first of equal names."""

    def __init__(self, data: bytes, bounded: bool = True):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
            members = self._zip.infolist()
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, EOFError, IndexError) as e:
            raise invalid(f"not a readable archive: {e}") from None
        if bounded and len(members) > MAX_MEMBERS:
            raise invalid(f"the archive lists {len(members)} members")
        self.members: dict[str, zipfile.ZipInfo] = {}
        for m in members:
            self.members.setdefault(m.filename, m)

    def __contains__(self, name: str) -> bool:
        return name in self.members

    def read(self, name: str, limit: int = MAX_MEMBER) -> tuple[bytes, Rejected | None]:
        """(what could be read, what went wrong). A member that unpacks to more than `limit` is an error."""
        member = self.members[name]
        if member.file_size > limit:
            return b"", invalid(f"member {name!r} says it unpacks to {member.file_size} bytes")
        parts, size = [], 0
        try:
            with self._zip.open(member) as f:
                while part := f.read(1 << 20):
                    size += len(part)
                    if size > limit:
                        return b"".join(parts), invalid(f"member {name!r} unpacks to more than {limit} bytes")
                    parts.append(part)
        except (zipfile.BadZipFile, zlib.error, OSError, ValueError, NotImplementedError, RuntimeError, EOFError) as e:
            return b"".join(parts), invalid(f"member {name!r} cannot be unpacked: {e}")
        return b"".join(parts), None

    def need(self, name: str) -> bytes:
        if name not in self:
            raise invalid(f"the archive has no member {name}")
        data, error = self.read(name)
        if error:
            raise error
        return data

    def head(self, name: str, size: int) -> str:
        """The first bytes of a small member as text, empty on any error."""
        try:
            with self._zip.open(self.members[name]) as f:
                return f.read(size).decode("utf-8", "replace")
        except Exception:
            return ""


def resolve(base: str, target: str) -> str:
    """The member that a relationship target names, seen from the folder `base`."""
    return target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))


@lru_cache(maxsize=1 << 12)
def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _declared(_version, encoding, _standalone):
    if encoding and encoding.lower() not in ("utf-8", "utf8"):
        raise expat.ExpatError(f"encoding {encoding}")


def is_plain_xml(data: bytes) -> bool:
    """Whether read_xml() would read `data` to its end, and every `<` in it begins a tag: no comments, sections, instructions or
    declarations of types."""
    parser = expat.ParserCreate("utf-8")
    parser.XmlDeclHandler = _declared

    def other(*_):
        raise ValueError

    parser.CommentHandler = parser.StartCdataSectionHandler = parser.ProcessingInstructionHandler = parser.StartDoctypeDeclHandler = other
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, UnicodeDecodeError, ValueError):
        return False
    return True


def read_xml(data: bytes, start=None, text=None, end=None) -> bool:
    """Feeds elements (local name, attributes by local name, attributes as written) and text to the handlers until
    the end (True) or the first error (False). Entities that a document declares itself are errors, as are encodings other
    than UTF-8."""
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def other(piece):
        if piece.startswith("&"):
            raise expat.ExpatError("entity")

    def opened(name, attributes):
        short: dict[str, str] = {}
        for k, v in attributes.items():
            short.setdefault(_local(k), v)
        start(_local(name), short, attributes)

    parser.XmlDeclHandler = _declared
    if start:
        parser.StartElementHandler = opened
    if end:
        parser.EndElementHandler = lambda name: end(_local(name))
    if text:
        parser.CharacterDataHandler = text
    else:
        parser.CharacterDataHandler = lambda _: None
    parser.DefaultHandler = other
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, UnicodeDecodeError, ValueError):
        return False
    return True


class Node:
    """An element with its attributes by local name; its children are nodes and texts. `whole` once its end tag was read."""

    __slots__ = ("name", "attributes", "children", "whole")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children, self.whole = name, attributes, [], False

    def find(self, *names: str) -> Iterator[Node]:
        """The outermost elements of these names within this one, in order."""
        for child in self.children:
            if isinstance(child, Node):
                if child.name in names:
                    yield child
                else:
                    yield from child.find(*names)

    def text(self, marks: dict[str, str] | None = None, within: str | None = None, without: str | None = None) -> str:
        """All text, with marks for the elements that stand for characters; only that within elements of one name, without that of another."""
        return "".join(self._texts(marks or {}, within, without))

    def _texts(self, marks: dict[str, str], within: str | None, without: str | None) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                if within is None:
                    yield child
            elif child.name != without:
                yield from (marks[child.name],) if child.name in marks else ()
                yield from child._texts(marks, None if child.name == within else within, without)


def each_element(data: bytes, names: Iterable[str], take: Callable[[Node], None], entered: Callable[[str, dict[str, str]], None] | None = None) -> bool:
    """Gives the outermost elements of these names to `take`, each as a tree once it ends, or once reading ends within it; `entered` hears
    of the elements outside them. Whether the document is well-formed."""
    names, open_nodes = set(names), []

    def start(name, attributes, _):
        if open_nodes or name in names:
            node = Node(name, attributes)
            if open_nodes:
                open_nodes[-1].children.append(node)
            open_nodes.append(node)
        elif entered:
            entered(name, attributes)

    def text(piece):
        if open_nodes:
            open_nodes[-1].children.append(piece)

    def end(_):
        if open_nodes:
            node = open_nodes.pop()
            node.whole = True
            if not open_nodes:
                take(node)

    well_formed = read_xml(data, start, text, end)
    if open_nodes:
        take(open_nodes[0])
    return well_formed
