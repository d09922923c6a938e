"""What is worked out on the driver when a plan is built: positions, regions, sky pixels, cosmology."""
