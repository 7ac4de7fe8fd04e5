from musterline.sources.files import read_answers, read_grid, read_grids

__all__ = ["read_answers", "read_grid", "read_grids"]
