"""See the package README section for the modules in here."""
