"""All registered queries; importing this package fills the registry."""

from veilframe.plans import detection, gateway, stores, streams, texts, usage
from veilframe.plans.detection import flagship
from veilframe.plans.registry import REGISTRY

__all__ = ["REGISTRY", "detection", "flagship", "gateway", "stores", "streams", "texts", "usage"]
