"""Sources: page rasters and text layers, and views of the driver's tables in those shapes."""
