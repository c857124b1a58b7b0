"""The layer file: which globs make a layer, and which layers it may use."""

from __future__ import annotations

import json
import os

from ..model import InvalidConfig
from ..operators.architecture import Layers


def parse_layers(text: str) -> Layers:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise InvalidConfig("the layer file is not JSON") from e
    if not isinstance(data, dict):
        raise InvalidConfig("the layer file must hold an object")
    layers, allowed = data.get("layers"), data.get("allowed_dependencies", {})
    for key, value in (("layers", layers), ("allowed_dependencies", allowed)):
        if not isinstance(value, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in value.values()):
            raise InvalidConfig(f"{key} must map names to lists of strings")
    for name, targets in allowed.items():
        for x in (name, *targets):
            if x not in layers:
                raise InvalidConfig(f"allowed_dependencies names {x!r}, which is no layer")
    return Layers(layers, allowed)


def load_layers(root: str, name: str = ".layers.json") -> Layers | None:
    """The layers of a repository; None without a file."""
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return parse_layers(f.read())
    except FileNotFoundError:
        return None
    except (OSError, UnicodeDecodeError) as e:
        raise InvalidConfig("the layer file can't be read") from e
