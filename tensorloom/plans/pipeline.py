"""Programs of blocks: sources, transforms and sinks that Spark runs as one plan.

A block is a node; its output is a lazy :class:`TensorFrame`.  Building a
pipeline checks every spec at once, running it is one action for each sink.
There is no scheduler here: Spark is it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from ..frame import TensorFrame
from ..spec import TensorSpec

_SCOPES: list[dict] = [{}]


@contextmanager
def scope(**settings) -> Iterator[dict]:
    """Settings for the blocks made inside; inner ones come first."""
    _SCOPES.append(_SCOPES[-1] | settings)
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def setting(name: str, default=None):
    return _SCOPES[-1].get(name, default)


class PipelineInitError(Exception):
    """A block cannot take what its inputs give."""


@dataclass
class Block:
    """A named operator with its inputs; subclasses may say what it does.

    Override ``on_spec`` (spec to spec, to check it early) and ``on_data``
    (frames to frame); or give the operator as a function.
    """

    name: str
    inputs: tuple[Block, ...] = ()
    operator: Callable[..., TensorFrame] | None = None
    options: dict = field(default_factory=dict)
    _made: TensorFrame | None = None

    def on_spec(self, *specs: TensorSpec) -> None:
        """Raise if the inputs do not fit."""

    def on_data(self, *frames: TensorFrame) -> TensorFrame:
        return self.operator(*frames, **self.options)

    def output(self) -> TensorFrame:
        if self._made is None:
            frames = [b.output() for b in self.inputs]
            try:
                self.on_spec(*[f.spec for f in frames])
                self._made = self.on_data(*frames)
            except (ValueError, KeyError, IndexError) as e:
                raise PipelineInitError(f"{self.name}: {e}") from e
            n = setting("persist_shared")
            if n and sum(1 for _ in self.inputs) > 1:
                self._made = TensorFrame(self._made.df.persist(), self._made.spec, self._made.keys)
        return self._made


class Pipeline:
    """Blocks and the sinks that make them run."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.sinks: list[tuple[Block, Callable[[TensorFrame], object]]] = []

    def source(self, frame: TensorFrame, name: str = "source") -> Block:
        return self._add(Block(name, (), lambda: frame))

    def block(self, operator: Callable[..., TensorFrame], *inputs: Block, name: str | None = None, **options) -> Block:
        return self._add(Block(name or operator.__name__, inputs, operator, options))

    def add(self, block: Block) -> Block:
        """A block of the user's own class."""
        return self._add(block)

    def sink(self, block: Block, write: Callable[[TensorFrame], object]) -> None:
        self.sinks.append((block, write))

    def _add(self, block: Block) -> Block:
        self.blocks.append(block)
        return block

    def check(self) -> dict[str, TensorSpec]:
        """All specs, without reading data."""
        return {f"{k}:{b.name}": b.output().spec for k, b in enumerate(self.blocks)}

    def run(self) -> list[object]:
        self.check()
        return [write(block.output()) for block, write in self.sinks]

    def dot_graph(self) -> str:
        """The program as a graph description."""
        number = {id(b): k for k, b in enumerate(self.blocks)}
        lines = [f'  b{k} [label="{b.name}"];' for k, b in enumerate(self.blocks)]
        lines += [f"  b{number[id(i)]} -> b{k};" for k, b in enumerate(self.blocks) for i in b.inputs]
        return "digraph pipeline {\n" + "\n".join(lines) + "\n}"


class Chain:
    """Fluent chaining: ``Chain(tf).split_axis("time", 4).reduce("time_split").frame``."""

    def __init__(self, frame: TensorFrame):
        self.frame = frame

    def custom(self, operator: Callable[..., TensorFrame], *args, **options) -> Chain:
        return Chain(operator(self.frame, *args, **options))

    def __getattr__(self, name: str):
        from ..operators import codec, dispersion, elementwise, fir, fourier, reduce, shape, views

        for module in (views, shape, elementwise, codec, reduce, fourier, fir, dispersion):
            if hasattr(module, name):
                return lambda *args, **options: self.custom(getattr(module, name), *args, **options)
        raise AttributeError(name)
