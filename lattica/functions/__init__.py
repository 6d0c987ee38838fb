"""Column functions that stay in generated code: Morton codes, comparisons as C gives them, harmonics, distances."""

from ..operators.combine import leaf_key, pick_less, pick_more
from ..operators.index import morton_decode, morton_encode
from ..operators.mesh import point_triangle_distance2
from ..operators.splats import sh_basis

__all__ = ["leaf_key", "morton_decode", "morton_encode", "pick_less", "pick_more", "point_triangle_distance2", "sh_basis"]
