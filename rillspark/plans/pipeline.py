"""Recorded chains of operators, played onto any flow; recording never changes a chain that exists."""

from __future__ import annotations

from typing import Any


class Pipeline:
    """An immutable list of (method, arguments); every flow method, extensions too, can be recorded."""

    def __init__(self, steps: tuple = ()):
        self._steps = steps

    def __getattr__(self, method: str):
        if method.startswith("__"):
            raise AttributeError(method)
        return lambda *args, **more: Pipeline((*self._steps, (method, args, more)))

    def __call__(self, flow: Any) -> Any:
        """Play the steps onto a flow; a step that is a pipeline's through() plays that one."""
        for method, args, more in self._steps:
            flow = getattr(flow, method)(*args, **more)
        return flow

    generate_stream = generateStream = __call__


def pipeline() -> Pipeline:
    return Pipeline()
