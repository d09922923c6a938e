"""Collections: redshift-stacked sky catalogues, linked structures, several simulations, sky maps, hosts."""
