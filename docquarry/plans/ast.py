"""The syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Keyword:
    tokens: tuple[str, ...]
    prf: int = 0

    def contains(self, token: str) -> bool:
        return token in self.tokens

    def extended(self, more: list[str]) -> Keyword:
        """The query of one feedback round: tokens added, no further feedback."""
        return Keyword(tuple(dict.fromkeys([*self.tokens, *more])))

    def __str__(self) -> str:
        return " ".join(self.tokens)


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prf: int = 0

    def contains(self, token: str) -> bool:
        return token in self.tokens

    def extended(self, more: list[str]) -> Mixed:
        return Mixed(replace(self, prf=0), Keyword(tuple(dict.fromkeys(more))))

    def __str__(self) -> str:
        return f'"{" ".join(self.tokens)}"'


@dataclass(frozen=True)
class Mixed:
    phrase: Phrase
    keyword: Keyword
    prf: int = 0

    def contains(self, token: str) -> bool:
        return self.phrase.contains(token) or self.keyword.contains(token)

    def extended(self, more: list[str]) -> Mixed:
        return Mixed(self.phrase, self.keyword.extended(more))

    def __str__(self) -> str:
        return f"{self.phrase} {self.keyword}"


@dataclass(frozen=True)
class LinkTo:
    doc_id: int
    prf: int = 0

    def __str__(self) -> str:
        return f"LinkTo:{self.doc_id}"


@dataclass(frozen=True)
class Boolean:
    left: Query
    op: str
    right: Query
    prf: int = 0

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


Query = Keyword | Phrase | Mixed | LinkTo | Boolean
