"""Named components, built when asked for; installed plugins may add to them, not replace them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib.metadata import entry_points
from typing import Any


class UnknownComponent(KeyError):
    def __init__(self, kind: str, name: str, known: list[str]) -> None:
        super().__init__(f"no {kind} named {name!r}; there are: {', '.join(known) or 'none'}")


class Registry:
    def __init__(self, kind: str, group: str | None = None) -> None:
        self.kind, self.group = kind, group
        self._makers: dict[str, Callable[..., Any]] = {}
        self._plugins = False

    def register(self, name: str, maker: Callable[..., Any]) -> None:
        self._makers[name] = maker

    def _load(self) -> None:
        if not self._plugins and self.group:
            for p in entry_points(group=self.group):
                if p.name not in self._makers:
                    self._makers[p.name] = p.load()
        self._plugins = True

    def create(self, name: str, *args: Any, **options: Any) -> Any:
        self._load()
        if name not in self._makers:
            raise UnknownComponent(self.kind, name, self.names())
        return self._makers[name](*args, **options)

    def build(self, name: str, **given: Any) -> Any:
        """A component made from those of the arguments that its maker takes."""
        from pagemill.plans.settings import fitting

        self._load()
        return self.create(name, **(fitting(self._makers[name], given) if name in self._makers else {}))

    def names(self) -> list[str]:
        self._load()
        return sorted(self._makers)

    def __contains__(self, name: object) -> bool:
        self._load()
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())
