"""Write policy as column expressions: attributes, protected names, roles, plans, decisions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute bits (fixed values).
NV, BS, RT, HR, AUTH, TIME_AUTH, APPEND, ENHANCED = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20, 0x40, 0x80
#: Protected names by namespace (fixed values).
SHIM_NAMES = ("MokList", "MokListX", "MokSBState", "MokDBState", "MokIgnoreDB", "MokListTrusted")
POLICY_NAMES = ("SecureBoot", "SetupMode", "AuditMode", "DeployedMode")
GLOBAL_KEYS, IMAGE_KEYS = ("PK", "KEK"), ("db", "dbx", "dbt", "dbr")
#: Namespaces by their GUIDs' stored bytes (fixed values).
NAMESPACES = {"61DFE48BCA93D211AA0D00E098032B8C": "global", "CBB219D73A3D9645A3BCDAD00E67656F": "image", "50AB5D6046E00043ABB63DD810DD8B23": "shim"}
#: Record states of the flash layout (fixed values).
ADDED, IN_TRANSITION = 0x3F, 0x3E
LEGAL_STATES = (0xFF, 0x7F, 0x3F, 0x3E, 0x3D, 0x3C)


def has(attributes: Column, bits: int) -> Column:
    return attributes.bitwiseAND(F.lit(bits)) != 0


def only(attributes: Column, bits: int) -> Column:
    return attributes.bitwiseAND(F.lit(0xFFFFFFFF & ~bits).cast("bigint")) == 0


def runtime_visible(attributes: Column) -> Column:
    return has(attributes, RT)


def writable_flash(attributes: Column) -> Column:
    """No bits but NV, BS, RT and HR, and both NV and BS."""
    return only(attributes, 0x0F) & (attributes.bitwiseAND(F.lit(3)) == 3)


def overlay_allowed(attributes: Column) -> Column:
    return only(attributes, 7) & has(attributes, BS)


def namespace_of(guid: Column, global_: Column, image: Column, shim: Column) -> Column:
    return F.when(guid == global_, "global").when(guid == image, "image").when(guid == shim, "shim").otherwise("other")


def namespace(guid: Column) -> Column:
    """The namespace of a stored GUID."""
    out = F
    for stored, name in NAMESPACES.items():
        out = out.when(F.hex(guid) == stored, name)
    return out.otherwise("other")


def protection(namespace: Column, name: Column) -> Column:
    """Why a key is protected: boot_services_only, policy, secure_boot_key or null."""
    return (
        F.when((namespace == "shim") & name.isin(*SHIM_NAMES), "boot_services_only")
        .when((namespace == "global") & name.isin(*POLICY_NAMES), "policy")
        .when(((namespace == "global") & name.isin(*GLOBAL_KEYS)) | ((namespace == "image") & name.isin(*IMAGE_KEYS)), "secure_boot_key")
    )


def role(namespace: Column, name: Column) -> Column:
    out = F.when((namespace == "global") & (name == "PK"), "PlatformKey").when((namespace == "global") & (name == "KEK"), "KeyExchangeKey")
    out = out.when((namespace == "global") & (name == "OsRecoveryOrder"), "OsRecovery")
    for key in IMAGE_KEYS:
        out = out.when((namespace == "image") & (name == key), key.capitalize())
    return out.otherwise("Private")


def mode(setup: Column, audit: Column, deployed: Column) -> Column:
    return F.when(deployed != 0, "Deployed").when(audit != 0, "Audit").when(setup != 0, "Setup").otherwise("User")


def selector(attributes: Column) -> Column:
    """The descriptor that an attribute word selects, or the error it selects nothing with."""
    return (
        F.when(~only(attributes, 0xFF), "Attributes")
        .when(has(attributes, AUTH), "Descriptor")
        .when(has(attributes, TIME_AUTH) & ~has(attributes, ENHANCED), "Authentication2")
        .when(~has(attributes, TIME_AUTH) & has(attributes, ENHANCED), "Authentication3")
        .otherwise("Descriptor")
    )


def plan(attributes: Column, value_size: Column, stored: Column) -> Column:
    append = has(attributes, APPEND)
    return F.when((value_size == 0) & append, "Append").when(value_size == 0, "Delete").when(append & stored, "Append").otherwise("Replace")


def auth_check(attributes: Column, descriptor: Column, time: Column, stored: Column, stored_attributes: Column, stored_time: Column, value_size: Column) -> Column:
    """The first broken rule of an authenticated request, or its plan. time: null without one, 0 if unspecified."""
    chosen, append = selector(attributes), has(attributes, APPEND)
    return (
        F.when(chosen.isin("Attributes", "Descriptor"), chosen)
        .when(chosen != descriptor, "Descriptor")
        .when(append & (chosen == "Authentication3"), "AppendWrite")
        .when(stored & (stored_attributes != attributes.bitwiseAND(F.lit(~APPEND))), "AttributeChange")
        .when(time.isNull(), plan(attributes, value_size, stored))
        .when((time == 0) & ~append, "TimeStamp")
        .when(append | ~stored, plan(attributes, value_size, stored))
        .when(stored_time.isNull(), "MissingTimeStamp")
        .when(time <= stored_time, "Stale")
        .otherwise(plan(attributes, value_size, stored))
    )


def mirror_decision(primary_ok: Column, spare_ok: Column, same: Column) -> Column:
    """What to do with a primary and a spare copy; a missing copy isn't ok."""
    p, s = F.coalesce(primary_ok, F.lit(False)), F.coalesce(spare_ok, F.lit(False))
    return F.when(p & s & same, "Unchanged").when(p, "Mirror").when(s, "Restore").otherwise("Invalid")


def deleting(attributes: Column, value_size: Column) -> Column:
    return (attributes == 0) | ((value_size == 0) & ~has(attributes, APPEND))


def operation(attributes: Column, value_size: Column, front: str) -> Column:
    """SET, APPEND or DELETE, as each front end reads a request: abi (the C interface), service (boot services), tool (the command line).

    The C interface looks for the append bit first, the services delete with attributes 0 whatever the bits,
    the tool knows no append.
    """
    empty, append = value_size == 0, has(attributes, APPEND)
    if front == "abi":
        return F.when(append, "APPEND").when((attributes == 0) | empty, "DELETE").otherwise("SET")
    if front == "service":
        return F.when(deleting(attributes, value_size), "DELETE").when(append, "APPEND").otherwise("SET")
    return F.when(empty, "DELETE").otherwise("SET")


#: Statuses of the store as the boot services tell them; any other is Corrupt (fixed values).
SERVICE = {
    "Full": "OutOfResources", "NotFound": "NotFound", "InvalidParameter": "InvalidParameter", "Name": "InvalidParameter", "Unsupported": "Unsupported",
    "SecurityViolation": "SecurityViolation", "Rollback": "SecurityViolation", "WriteProtected": "WriteProtected", "Locked": "WriteProtected",
}
#: Numbers of those as EFI_STATUS errors, without the top bit (fixed values).
EFI = {"InvalidParameter": 2, "Unsupported": 3, "BufferTooSmall": 5, "Device": 7, "WriteProtected": 8, "OutOfResources": 9, "NotFound": 14, "SecurityViolation": 26, "Corrupt": 33}
#: Numbers of the store's statuses in the C interface; any other is the device error (fixed values).
ABI = {"Full": 9, "WriteProtected": 8, "SecurityViolation": 26, "Unsupported": 3, "Name": 2, "InvalidParameter": 2, "NotFound": 14}


def mapped(error: Column, table: dict, other) -> Column:
    """An error by a table; OK and Success stay null."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(~error.isin("OK", "Success"), F.coalesce(F.get(F.array(known[error]), F.lit(0)), F.lit(other)))


def service_error(error: Column) -> Column:
    return mapped(error, SERVICE, "Corrupt")


def efi_status(service: Column) -> Column:
    return mapped(service, EFI, EFI["Device"])


def abi_status(error: Column) -> Column:
    return mapped(error, ABI, 7)


def manifest_status(size: Column, write_unit: Column, backing_size: Column, backing_unit: Column) -> Column:
    """Whether a manifest has a write unit that is a power of two and describes the same store as its backing."""
    fine = (write_unit > 0) & (write_unit.bitwiseAND(write_unit - 1) == 0) & (size == backing_size) & (write_unit == backing_unit)
    return F.when(fine, "OK").otherwise("InvalidParameter")


def posture_tier() -> Column:
    """The only posture that is built: 0."""
    return F.lit(0)


def later_time(old: Column, new: Column) -> Column:
    """The time that an authenticated append leaves: the later of two, the new one where none is stored."""
    return F.greatest(old, new)


def size_matches(content: Column, size: Column) -> Column:
    """A copy counts only with exactly the store's size."""
    return F.length(content) == size
