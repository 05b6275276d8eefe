"""ZIP containers, with guards against what they unpack to."""

from __future__ import annotations

import io
import posixpath
import zipfile

from folioflow.schema import MAX_UNPACKED_BYTES
from folioflow.sources.markup import parse_xml


class RefusedArchive(ValueError):
    pass


class Archive:
    def __init__(self, content: bytes, most: int = MAX_UNPACKED_BYTES):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise RefusedArchive("not a ZIP file") from e
        total = sum(i.file_size for i in self.zip.infolist())
        if total > most:
            raise RefusedArchive(f"unpacks to {total} bytes, more than {most}")
        self.names = set(self.zip.namelist())

    def read(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def xml(self, name: str):
        raw = self.read(name)
        return None if raw is None else parse_xml(raw)

    def relations(self, part: str) -> dict[str, str]:
        """Targets by id of a part's relations, as full names."""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", name + ".rels"))
        if root is None:
            return {}
        out = {}
        for r in root:
            target = r.get("Target") or ""
            if r.get("TargetMode") == "External":
                out[r.get("Id")] = target
            else:
                out[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def core_properties(self) -> dict[str, str]:
        """The document properties by local name; none if they can't be read."""
        try:
            root = self.xml("docProps/core.xml")
        except Exception:  # noqa: BLE001  metadata is taken as far as it can be read
            return {}
        return {} if root is None else {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in root if (e.text or "").strip()}


def properties(archive: Archive) -> dict:
    """Title, author and so on, under the names of the document model."""
    own = archive.core_properties()
    names = {"title": "title", "creator": "author", "subject": "subject", "description": "description", "created": "created_at", "modified": "modified_at"}
    out: dict = {to: own[k] for k, to in names.items() if k in own}
    if "keywords" in own:
        out["keywords"] = [k.strip() for k in own["keywords"].replace(";", ",").split(",") if k.strip()]
    return out
