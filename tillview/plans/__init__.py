"""Reports of the three pages and the campaign job."""
