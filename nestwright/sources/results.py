"""What writes report, and the writes of a bulk."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class InsertResult:
    inserted_ids: list

    @property
    def inserted_id(self):
        return self.inserted_ids[0]


@dataclass(frozen=True)
class UpdateResult:
    matched_count: int
    modified_count: int
    upserted_id: object = None


@dataclass(frozen=True)
class DeleteResult:
    deleted_count: int


@dataclass
class BulkResult:
    inserted_count: int = 0
    matched_count: int = 0
    modified_count: int = 0
    deleted_count: int = 0
    upserted_ids: dict = field(default_factory=dict)

    @property
    def upserted_count(self) -> int:
        return len(self.upserted_ids)


@dataclass(frozen=True)
class InsertOne:
    document: dict


@dataclass(frozen=True)
class UpdateOne:
    filter: dict
    update: dict
    upsert: bool = False


@dataclass(frozen=True)
class UpdateMany:
    filter: dict
    update: dict
    upsert: bool = False


@dataclass(frozen=True)
class ReplaceOne:
    filter: dict
    replacement: dict
    upsert: bool = False


@dataclass(frozen=True)
class DeleteOne:
    filter: dict


@dataclass(frozen=True)
class DeleteMany:
    filter: dict


class IndexModel:
    """An index to make, for create_indexes."""

    def __init__(self, keys, name: str | None = None, **options):
        self.keys, self.name, self.options = keys, name, options
