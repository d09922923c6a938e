"""Several simulations side by side: verbs go to each member, whose columns and cosmologies may differ."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from ..functions.errors import MissingColumnError
from ..functions.expr import Expr
from ..operators.dataset import Dataset, matching


class SimulationCollection(dict):
    """A dict of datasets or collections."""

    def _map(self, verb: str, *args: Any, datasets: str | Iterable[str] | None = None, **kwargs: Any) -> SimulationCollection:
        """Calls a verb of each member, or those named; a dict argument whose keys are the members' names is split among them."""
        chosen = list(self) if datasets is None else [datasets] if isinstance(datasets, str) else list(datasets)
        if unknown := [n for n in chosen if n not in self]:
            raise ValueError(f"no members {', '.join(unknown)}")
        out = dict(self)
        for n in chosen:
            mine = {k: v[n] if isinstance(v, dict) and v and set(v) == set(self) else v for k, v in kwargs.items()}
            out[n] = getattr(self[n], verb)(*args, **mine)
        return SimulationCollection(out)

    def filter(self, *masks, **kwargs): return self._map("filter", *masks, **kwargs)
    def take(self, n: int, at: str = "random", **kwargs): return self._map("take", n, at, **kwargs)
    def take_range(self, start: int, end: int, **kwargs): return self._map("take_range", start, end, **kwargs)
    def sort_by(self, column, invert: bool = False, **kwargs): return self._map("sort_by", column, invert, **kwargs)
    def bound(self, region, **kwargs): return self._map("bound", region, **kwargs)
    def with_units(self, convention=None, **kwargs): return self._map("with_units", convention, **kwargs)

    def _route(self, verb: str, names: list[str], datasets: Any) -> SimulationCollection:
        """Each name goes to the members that have it, wildcards to all; a name that none has is an error."""
        chosen = list(self) if datasets is None else [datasets] if isinstance(datasets, str) else list(datasets)
        if not all(isinstance(self[n], Dataset) for n in chosen):
            return self._map(verb, *names, datasets=chosen)
        for name in names:
            if not any(matching(self[n].columns, name) if "*" in name else name in self[n].columns for n in chosen):
                raise MissingColumnError(f"no member has a column {name!r}")
        out = dict(self)
        for n in chosen:
            mine = [c for c in names if (matching(self[n].columns, c) if "*" in c else c in self[n].columns)]
            if mine or verb == "select":
                out[n] = getattr(self[n], verb)(*mine)
        return SimulationCollection(out)

    def select(self, *columns: str | Iterable[str], datasets: Any = None, **derived: Expr) -> SimulationCollection:
        names = [n for c in columns for n in ([c] if isinstance(c, str) else c)]
        if derived:
            return self._map("select", *names, datasets=datasets, **derived)
        return self._route("select", names, datasets)

    def drop(self, *columns: str | Iterable[str], datasets: Any = None) -> SimulationCollection:
        return self._route("drop", [n for c in columns for n in ([c] if isinstance(c, str) else c)], datasets)

    def with_new_columns(self, *args: Any, datasets: Any = None, **new: Any) -> SimulationCollection:
        """An expression goes to the members that have its inputs."""
        if args or not all(isinstance(self[n], Dataset) for n in self):
            return self._map("with_new_columns", *args, datasets=datasets, **new)
        chosen = set(self) if datasets is None else {datasets} if isinstance(datasets, str) else set(datasets)
        out, used = dict(self), set()
        for n in chosen:
            split = {k: v[n] if isinstance(v, dict) and set(v) == set(self) else v for k, v in new.items()}
            have = set(self[n].columns) | set(split)
            mine = {k: v for k, v in split.items() if not isinstance(v, Expr) or v.names() <= have}
            used |= set(mine)
            if mine:
                out[n] = self[n].with_new_columns(**mine)
        if lost := set(new) - used:
            raise MissingColumnError(f"no member has what {', '.join(sorted(lost))} reads")
        return SimulationCollection(out)

    def evaluate(self, func: Callable, datasets: Any = None, insert: bool = True, **kwargs: Any) -> Any:
        done = self._map("evaluate", func, datasets=datasets, insert=insert, **kwargs)
        return done if insert else {n: done[n] for n in ([datasets] if isinstance(datasets, str) else datasets or self)}

    @property
    def header(self): return {n: m.header for n, m in self.items()}
    @property
    def cosmology(self): return {n: m.cosmology for n, m in self.items()}
    @property
    def redshift(self): return {n: m.redshift for n, m in self.items()}
    @property
    def simulation(self): return {n: m.simulation for n, m in self.items()}
    @property
    def dtype(self): return {n: m.dtype for n, m in self.items()}
