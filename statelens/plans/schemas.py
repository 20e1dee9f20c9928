"""Schemas of the engine's tables."""

from __future__ import annotations

#: One flattened tensor of one instance and layer.
ACTIVATIONS = "run_id string, layer string, instance_id bigint, label int, activations array<float>"
#: The catalog: neurons are a property of the layer, never the size of a row's array.
LAYERS = "model_id string, layer string, layer_class string, ordinal int, n_neurons int, shape array<int>, channel_axis int, capture_on boolean"
STATES = "run_id string, layer string, instance_id bigint, position int, state bigint"
WIDE_STATES = "run_id string, layer string, instance_id bigint, position int, state binary"
