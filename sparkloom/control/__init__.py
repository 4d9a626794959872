"""What changes files: on the driver, outside any plan."""
