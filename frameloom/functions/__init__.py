"""Column functions on boxes, masks and keypoints, and pixel functions in numpy."""
