"""cloakframe: detection, pseudonymisation and restoration of personal data as Spark plans."""
