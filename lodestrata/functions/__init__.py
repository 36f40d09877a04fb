"""Part of lodestrata; see the package README."""
