"""Part of quartzgrid; see the README for the map of modules."""
